"""careerloom.sources"""
