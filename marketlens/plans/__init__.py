"""marketlens.plans"""
