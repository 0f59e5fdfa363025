"""The library's operators run on the given tables, with equivalent SQL for comparison."""
