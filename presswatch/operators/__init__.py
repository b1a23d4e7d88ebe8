"""Table operators: DataFrame in, DataFrame out, parameters explicit."""
