"""Named queries over the fixture tables."""
