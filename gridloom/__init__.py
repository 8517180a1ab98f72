"""Gridloom: dense-grid analytics and outlier flagging expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
