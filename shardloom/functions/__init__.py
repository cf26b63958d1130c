"""Small helpers: identifier rules, shipping of this package."""
