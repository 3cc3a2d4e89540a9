"""foliospark.functions"""
