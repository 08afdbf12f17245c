"""careerloom.operators"""
