"""Training-data operators: token counts, search, archives, secrets, quality, joins, packing, shards.

Every operator takes and returns DataFrames, names its input columns by parameter and ignores any
other column of its input.  Nothing outside this subpackage imports it.
"""
