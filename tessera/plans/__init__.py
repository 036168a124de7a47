"""Named queries over the supplied tables, with equivalent SQL."""
