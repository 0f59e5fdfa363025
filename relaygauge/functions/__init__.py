"""Column functions: text, frames, row keys, timing pairs, time."""
