"""Report catalogue: each report is a function of the role tables.

Output column names are the reports' own labels. Columns are documented where a rule
is not plain from the code; ``as_of`` is the report time.
"""
