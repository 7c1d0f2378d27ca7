"""PySpark-native analytics over code facts, JSON, trees and text corpora."""
