"""folioframe.operators"""
