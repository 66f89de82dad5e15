"""meshspark.sources"""
