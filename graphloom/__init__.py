"""Graphloom: a property-graph analytics engine on Spark.

Sources and extractors give observations; canonicalization folds them into nodes, edges, evidence and links; operators and the
session's catalogue of queries read those tables. All plans are DataFrame expressions; Python runs in extractors and few functions.
"""
