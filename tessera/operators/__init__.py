"""Operators on tables: views, profiles and flow analytics."""
