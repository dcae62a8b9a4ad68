"""Registered queries and their oracle SQL, by theme."""
