"""Training-data operators: one module an operator, all of them DataFrame in, DataFrame out."""
