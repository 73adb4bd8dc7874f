"""Operators for preparing training data, one module per problem.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
