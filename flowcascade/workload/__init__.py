"""The queries run over the driver tables, and their SQL counterparts."""
