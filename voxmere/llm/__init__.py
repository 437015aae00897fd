"""Training-data operators over document tables. Nothing else in voxmere imports this subpackage."""
