"""marketlens.streaming"""
