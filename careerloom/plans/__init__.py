"""careerloom.plans"""
