"""Column-level building blocks: numeric helpers, timestamps, transforms, features."""
