"""lodegraph.streaming"""
