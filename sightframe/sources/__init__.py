"""Where images and requests come from, and where records go."""
