"""careerloom.functions"""
