"""Operators from rows of images to rows of facts."""
