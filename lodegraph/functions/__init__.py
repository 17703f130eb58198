"""lodegraph.functions"""
