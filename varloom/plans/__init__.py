"""Plan building blocks and whole-analysis compositions."""
