"""Operators for preparing training text at scale. Nothing else in mutagrid imports this package."""
