"""argosy: a PySpark-native engine for analysing large sets of company filings."""
