"""Readers and writers: CSV sources, the order/line star, result files, published runs."""
