"""Part of tapeloom: plans."""
