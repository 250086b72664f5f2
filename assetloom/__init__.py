"""assetloom: corpus-scale asset analytics expressed as Spark DataFrames.

Assets, their facts, tags, pixels, candidate renditions, benchmark runs and
build outputs are tables; change feeds are streams; every operator takes and
returns DataFrames (or Columns) and leaves physical planning to Catalyst.
"""
