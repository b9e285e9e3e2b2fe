"""Text expressions and seeded draws."""
