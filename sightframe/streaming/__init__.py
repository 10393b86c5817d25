"""Images as they arrive: an extension, with the same operators as for batches."""
