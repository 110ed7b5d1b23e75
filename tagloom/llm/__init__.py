"""Operators for preparing training text: each module is one operator, on whole tables of any size."""
