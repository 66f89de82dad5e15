"""meshspark.functions"""
