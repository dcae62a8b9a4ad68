"""Subpackage of lodeworks."""
