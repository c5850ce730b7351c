"""marketlens.functions"""
