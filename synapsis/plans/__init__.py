"""How steps of a plan are put together and stored."""
