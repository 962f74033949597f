"""The registered queries: every operator run over whole given tables, most with an SQL twin."""
