"""lodegraph.sources"""
