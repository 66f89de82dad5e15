"""meshspark.streaming"""
