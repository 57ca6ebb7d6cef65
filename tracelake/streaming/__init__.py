"""Byte streams and stateful operators, each with a batch twin."""
