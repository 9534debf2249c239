"""folioframe.functions"""
