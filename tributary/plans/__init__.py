"""The table bundle and the query pack over it."""
