"""Part of tapeloom: functions."""
