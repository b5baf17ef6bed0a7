"""Query catalogue and its SQL twins."""
