"""From folders and requests to an index, and from questions to answers."""
