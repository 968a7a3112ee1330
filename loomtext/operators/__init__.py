"""operators of the text analytics engine."""
