"""Session helpers and composed plans."""
