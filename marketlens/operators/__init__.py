"""marketlens.operators"""
