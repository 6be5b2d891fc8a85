"""Training-data operators: filters, de-duplication, packing, mixing, search and storage.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; ``queries`` binds the operators to the synthetic tables.
"""
