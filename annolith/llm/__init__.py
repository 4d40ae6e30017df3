"""Operators for preparing training text at scale; nothing else in annolith imports this subpackage."""
