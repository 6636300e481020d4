"""Tapeloom: analytics over recorded message-protocol traffic, as Spark jobs."""
