"""No streaming operators.

The reference reads whole stored tables in batch jobs; it has no stream,
watermark or stateful operator, so none is built here (see README).
"""
