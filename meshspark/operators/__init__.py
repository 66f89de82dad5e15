"""meshspark.operators"""
