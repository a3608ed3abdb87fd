"""Training-data operators for text and vector tables.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
