"""Market analytics over auction listings, as Spark jobs: DataFrame in, DataFrame out."""
