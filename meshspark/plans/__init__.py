"""meshspark.plans"""
