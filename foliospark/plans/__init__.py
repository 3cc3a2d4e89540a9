"""foliospark.plans"""
