"""Stage composition."""
