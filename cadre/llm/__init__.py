"""Training-data operators over document tables.

One module per operator; ``queries`` registers the thin ``opN_*`` queries.
Nothing else in the library imports this package.
"""
