"""Part of tapeloom: streaming."""
