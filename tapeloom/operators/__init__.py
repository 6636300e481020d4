"""Part of tapeloom: operators."""
