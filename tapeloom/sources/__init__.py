"""Part of tapeloom: sources."""
