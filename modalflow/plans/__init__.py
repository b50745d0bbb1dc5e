"""Plan builders that combine operators."""
