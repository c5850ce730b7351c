"""marketlens.sources"""
