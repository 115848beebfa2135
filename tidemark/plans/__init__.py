"""Reports over the event table."""
