"""functions of the text analytics engine."""
