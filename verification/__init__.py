"""Registered queries over the order/line star tables and their SQL counterparts."""
