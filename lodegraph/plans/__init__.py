"""lodegraph.plans"""
