"""Query languages over JSON and trees."""
