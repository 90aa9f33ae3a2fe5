"""lodestone.functions"""
