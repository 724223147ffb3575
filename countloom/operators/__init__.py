"""Relational operators on long count tables: screens, transforms, contrasts."""
