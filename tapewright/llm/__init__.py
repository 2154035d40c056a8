"""Training-data operators: token counts, de-duplication, filters, packing. Nothing outside this subpackage imports it."""
