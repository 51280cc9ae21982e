"""The registered queries (name -> callable(spark, sf_dir)) and their DuckDB oracle SQL."""
