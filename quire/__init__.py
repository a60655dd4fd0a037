"""quire: ingesting, searching and analysing collections of page-structured documents as DataFrames."""
