"""tidemark: drawdown-risk jobs over panels of series, and text-corpus jobs, on PySpark."""
