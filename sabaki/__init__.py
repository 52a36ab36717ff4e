"""Typed purchase records from the text of auction statements, as Spark DataFrame operators."""
